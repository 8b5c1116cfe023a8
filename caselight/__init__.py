"""caselight: support-case analytics written as PySpark DataFrame programs."""
