"""Code for executors that do not have this package on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_sent: set[str] = set()


def ship(spark) -> None:
    """Sends the package to the executors of a session, once, unless PYTHONPATH names its folder already."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _sent or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _sent.add(app)
    at = Path(tempfile.mkdtemp(prefix="pixelloom-")) / "pixelloom_code.zip"  # on the driver only; Spark hands it out
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "pixelloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
