"""textlab: imbalanced text-labelling data sets built and judged on Spark.

Every operator is either ``DataFrame -> DataFrame`` (usable with
``df.transform``) or ``Column -> Column``.  Nothing in the row path runs
Python; the work is declared with the DataFrame API and planned by Catalyst.
"""

__version__ = "0.1.0"
