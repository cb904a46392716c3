"""Log severity analytics as Spark jobs.

``functions`` holds column expressions, ``sources`` the readers and writers,
``operators`` the keyed and grouped work, ``plans`` the end-to-end jobs and
``streaming`` the continuous form of the scoring job.
"""

import sys

from pyspark import cloudpickle

# Helper functions travel with the tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
