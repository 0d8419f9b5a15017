import sys

from .plans.analyze import main

sys.exit(main())
