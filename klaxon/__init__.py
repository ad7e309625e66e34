"""klaxon: alarm analytics written as PySpark DataFrame operators."""
