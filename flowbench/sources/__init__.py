"""Reading flow tables and keeping intermediate ones."""
