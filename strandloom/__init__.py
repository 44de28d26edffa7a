"""Analytics on sequence strings as DataFrame plans."""
