"""docmetrics: document-metric analytics as Spark DataFrame operators.

Documents -> elements -> chunks -> hashed vectors -> k-nearest chunks per
metric query -> rule extraction -> validation -> reports. Every operator
takes DataFrames and returns a DataFrame; a few write an intermediate table or collect a bounded one on the way.
"""

import sys

from pyspark import cloudpickle

# Python workers may not have this package on their path (a job submitted
# from a notebook or a driver script): ship UDF code by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from docmetrics.session import get_session, scratch_dir  # noqa: E402

__all__ = ["get_session", "scratch_dir"]
