import sys

from sozmill.cli import main

sys.exit(main())
