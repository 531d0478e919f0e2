"""Image helpers: MIME type, data URL (FN12) and the size-budget plan (FN19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted image extensions (lower-case, no dot) and their MIME types.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png"]
MIME_BY_EXTENSION = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}
# Fixed value: the upload budget in megabytes.
DEFAULT_BUDGET_MB = 3.0
MEGABYTE = 1024 * 1024


def extension(name: Column) -> Column:
    """Lower-cased suffix after the last dot ('' when there is none)."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def mime_type(name: Column) -> Column:
    ext = extension(name)
    out = F.lit("application/octet-stream")
    for e, m in reversed(list(MIME_BY_EXTENSION.items())):
        out = F.when(ext == e, F.lit(m)).otherwise(out)
    return out


def data_url(content: Column, mime: Column) -> Column:
    """FN12: ``data:<mime>;base64,<payload>`` in one line (needs
    ``spark.sql.chunkBase64String.enabled=false``)."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def size_plan(length: Column, width: Column, height: Column,
              budget_mb: float = DEFAULT_BUDGET_MB) -> Column:
    """FN19: ``struct(size_mb, scale, new_width, new_height)``.  Above the budget the
    scale is ``sqrt(budget/size)`` and each side is truncated; otherwise 1.0 and the
    original sides."""
    size_mb = length / F.lit(float(MEGABYTE))
    over = size_mb > F.lit(budget_mb)
    scale = F.when(over, F.sqrt(F.lit(budget_mb) / size_mb)).otherwise(F.lit(1.0))
    new_w = F.when(over, F.floor(width * scale)).otherwise(width).cast("bigint")
    new_h = F.when(over, F.floor(height * scale)).otherwise(height).cast("bigint")
    return F.struct(size_mb.alias("size_mb"), scale.alias("scale"),
                    new_w.alias("new_width"), new_h.alias("new_height"))
