"""Sending this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext


def ship(sc: SparkContext) -> None:
    """Add the package to the context's files, once, so that executors can import it wherever the driver runs."""
    if getattr(sc, "_millrace_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="millrace-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "millrace_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(path)
    sc._millrace_shipped = True
