import sys

from shardloom.plans.commands import main

sys.exit(main())
