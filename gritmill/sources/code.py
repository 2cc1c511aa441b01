"""Source files of several languages: each goes to the reader of its language, and no file stops the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language_of
from .javascript import read_javascript
from .python_code import read_python


def read_code(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """The outline of each file with its language and status: analyzed, parse_failed, or unsupported, which has no symbol
    but the file. The columns are those of :data:`javascript.SCHEMA` and language. Each language is one narrow pass over its own
    files; null texts count as empty, null paths are unsupported, repeated rows are read each."""
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("content"), language_of(F.col(path)).alias("language"))
    script = rows.where(F.col("language").isin("javascript", "typescript"))
    scripts = read_javascript(script).withColumn("language", language_of(F.col("path")))
    none = F.array().cast(scripts.schema["exports"].dataType)
    parsed = read_python(rows.where("language = 'python'")).withColumns({"exports": none, "status": F.lit("analyzed"), "error": F.lit(None).cast("string"), "comment_count": F.lit(0), "language": F.lit("python")})
    others = rows.where(~F.col("language").isin("javascript", "typescript", "python")).withColumn("n", F.size(F.split(F.coalesce("content", F.lit("")), "\n")))
    file = F.struct(F.lit("FILE").alias("type"), F.col("path").alias("name"), F.lit(1).alias("start"), F.col("n").alias("end"))
    fixed = {"path": F.col("path"), "line_count": F.col("n"), "symbols": F.array(file), "status": F.lit("unsupported"), "error": F.lit(None).cast("string"), "comment_count": F.lit(0), "language": F.col("language")}
    rest = others.select(*[fixed.get(f.name, F.array().cast(f.dataType)).alias(f.name) for f in scripts.schema])
    return scripts.unionByName(parsed).unionByName(rest)
