"""Training-data operators: one module per operator, thin queries in ``queries``.

Nothing outside this folder imports it (the driver entry adds its queries when
the folder is present).  Every operator takes DataFrames and returns
DataFrames; Python runs only inside Arrow batches.
"""
