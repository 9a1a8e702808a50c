"""python -m sextant [command] [options] [paths]: reports and checks on one project."""

import sys

from sextant.cli import main

sys.exit(main(sys.argv[1:]))
