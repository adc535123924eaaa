"""Part of the product-ranking engine."""
