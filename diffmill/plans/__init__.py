"""Plan building blocks, test views and the registered queries."""
