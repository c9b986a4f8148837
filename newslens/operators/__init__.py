"""DataFrame to DataFrame operators, chainable with ``df.transform``."""
