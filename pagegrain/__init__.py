"""DataFrame operators for digitised document archives.

Every public function takes DataFrames (or Columns) and returns a lazy
DataFrame (or Column); no function in the package runs an action.
"""

__version__ = "0.1.0"
