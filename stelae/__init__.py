"""Stelae: a PySpark engine for content-addressed, versioned knowledge.

Everything is a DataFrame in and a DataFrame out.  ``functions`` holds column
expressions, ``operators`` whole-table operators, ``sources`` readers and
writers, ``plans`` the registered queries, ``streaming`` the live variants and
``llm`` the operators for preparing training text.  Nothing outside ``llm``
imports it.
"""

__version__ = "0.2.0"
