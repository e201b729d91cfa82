"""The three flows: demand, trend and price features."""
