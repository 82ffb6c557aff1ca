"""parlance: text-intent analytics expressed as Spark DataFrame jobs.

Every operator is a function ``f(df, ...) -> DataFrame`` whose column
names are parameters.  Featurisation, slot replacement, context windows
and evaluation are built-in Spark SQL expressions (whole-stage codegen);
models are ``pyspark.ml`` pipelines.
"""

from parlance.session import checkpoint_dir, get_session, scratch_path

__all__ = ["get_session", "checkpoint_dir", "scratch_path"]
