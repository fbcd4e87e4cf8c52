import sys

from vertexloom.plans.cli import main

sys.exit(main())
