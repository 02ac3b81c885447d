"""Analytics over small list programs, and the dataset pipeline around them, on PySpark."""
