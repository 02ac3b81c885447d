"""The program space and how it is split."""
