"""tidemark: measure how well marks hidden in source code survive rewrites.

Corpus build -> perturb -> pair -> score -> report, expressed as Spark
DataFrame jobs. Every public function takes and returns DataFrames.
"""

__version__ = "0.1.0"
