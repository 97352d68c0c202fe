"""DataFrame operators, one module for each family of the inventory."""
