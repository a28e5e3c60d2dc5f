"""inkmill: document dataflow on Spark DataFrames."""

import os
import sys
from pathlib import Path


def _ship_with_functions() -> None:
    """Pickle this package's functions by value where workers can't import it.

    Python workers see PYTHONPATH, not the driver's ``sys.path``. With the
    package's folder on PYTHONPATH (or installed) workers import it and keep
    their module-level caches between tasks.
    """
    home = Path(__file__).resolve().parent.parent
    known = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if home in known or "site-packages" in home.parts:
        return
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_with_functions()
