import sys

from quern.shell import main

sys.exit(main())
