"""tessera: irregular clinical laboratory events to gridded tensors, on Spark.

Every public function takes DataFrames and returns a lazy DataFrame; nothing is
collected on the driver.  Start with :func:`tessera.session.configure`.
"""

from tessera.session import configure, local_session

__all__ = ["configure", "local_session"]
