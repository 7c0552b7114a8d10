"""Fleet behaviour analytics and training-data pipelines on Spark."""

from __future__ import annotations


def ship(spark) -> str:
    """Send this package to the workers of a session that can't import it, as where it isn't installed on the cluster; the archive's name.

    Spark hands the archive to every executor, also to ones that come later. Once a session is enough.
    """
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="roadlark-")) / "roadlark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    return archive.name
