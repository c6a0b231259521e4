"""descry: descriptor-table analytics on Spark DataFrames.

A descriptor table has one row per entity: a unique ``id``, a target ``y`` that is
null for the rows to be predicted, and numeric descriptor columns.
"""

ID = "id"
TARGET = "y"
FEATURES = "features"
