"""Make the package importable for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the session's workers, once, unless their path has it already.

    Workers inherit the driver's working folder and PYTHONPATH (on a cluster, where the same paths
    are set); otherwise the sources go along as a zip file.
    """
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if ROOT in paths or Path.cwd() == ROOT or getattr(context, "_toponexus_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="toponexus-sources-")  # workers fetch it from the driver at any time
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/toponexus_sources.zip"
    with zipfile.ZipFile(name, "w") as out:
        for source in [*sorted((ROOT / "toponexus").rglob("*.py")), *ROOT.glob("corpus_*.py")]:
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(name)
    context._toponexus_shipped = True
