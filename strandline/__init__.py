"""Strandline: property-graph and training-data analytics as Spark plans."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Give this package to the executors of the session's application, once; the driver serves the file."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-code-"), "strandline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.join("strandline", os.path.relpath(os.path.join(folder, name), root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
