"""triarm: three-arm replicated evaluation on Spark.

Labelled text becomes a canonical table; many reproducible train / extra / test
splits are drawn from it in one job; the arms ``base``, ``extra`` and ``test``
are scored; and the accuracy table is analysed with paired differences,
two-level means, permutation tests, rank correlations and draw summaries.
"""
