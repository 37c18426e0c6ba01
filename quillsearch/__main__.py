"""``python -m quillsearch`` runs the command line."""

from .service.cli import main

main()
