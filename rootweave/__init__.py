"""Network-medicine and table-quality operators written as Spark DataFrame plans."""
