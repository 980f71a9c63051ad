"""Token-budgeted context selection and corpus processing on PySpark."""
