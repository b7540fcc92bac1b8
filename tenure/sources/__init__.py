"""Where the tables come from and where the repairs go."""
