"""labelworks: Spark operators for human and model annotations at scale.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing is
evaluated until the caller asks for it, unless a docstring says otherwise.
"""
