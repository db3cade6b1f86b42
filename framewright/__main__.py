import sys

from framewright.program import main

sys.exit(main())
