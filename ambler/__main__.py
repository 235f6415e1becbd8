from ambler.cli import main

main()
