import sys

from lumenspan.cli import main

sys.exit(main())
