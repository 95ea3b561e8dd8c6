"""Makes the package known to Python workers that cannot import it by themselves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources with the application, once, unless workers find them on their path or in their folder."""
    paths = {str(Path(p or ".").resolve()) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    app = spark.sparkContext.applicationId
    if str(_ROOT) in paths or app in _shipped:
        return
    with tempfile.TemporaryDirectory() as place:
        source = Path(place, "source")
        shutil.copytree(_ROOT / "tessera", source / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
        served = tempfile.mkdtemp()  # by the driver, as long as it runs
        atexit.register(shutil.rmtree, served, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(str(Path(served, "tessera")), "zip", source))
    _shipped.add(app)
