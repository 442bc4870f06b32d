"""papyra: Spark-native paper-corpus analytics and vector search.

Every operator takes and returns DataFrames. Work is declared with the
DataFrame API so Catalyst plans it; the only Python on the hot path is the
Arrow-batched scoring / encoding kernels in ``papyra.functions.vectors``.
"""

__version__ = "0.1.0"
