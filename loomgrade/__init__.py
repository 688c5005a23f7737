"""loomgrade: a Spark-native engine for ranking and maintaining collections of short procedural documents.

The modules hold declarative DataFrame plans. `plans.catalog` names every operator as a query.
"""

__version__ = "0.1.0"
