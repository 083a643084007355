from chronoloom.cli import main

raise SystemExit(main())
