"""Training-data operators: scoring, extraction, deduplication, decontamination,
secret and licence scans, and source mixing over a corpus of documents.

Nothing else in the library imports this subpackage.  Its Python functions run
on executors; they are pickled by value, so a cluster needs no copy of the
package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
