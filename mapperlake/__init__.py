"""mapperlake: mapper-XML analytics and relational kernels on PySpark."""
