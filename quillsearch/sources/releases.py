"""Lists of prebuilt database files, split parts grouped under their database."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = r"\.db(-\d+)?\.gz$"


def databases(files: DataFrame, column: str = "name") -> DataFrame:
    """base, files: database files by the name before ``.db``, parts in order."""
    wanted = files.where(F.col(column).rlike(NAME))
    return wanted.groupBy(F.split(column, r"\.db")[0].alias("base")).agg(F.array_sort(F.collect_list(column)).alias("files")).orderBy("base")


def join_parts(paths: list[str], target: str) -> int:
    """Unpack gzip parts one after another into a file; returns its bytes."""
    import gzip
    import shutil

    with open(target, "wb") as out:
        for path in sorted(paths):
            with gzip.open(path) as part:
                shutil.copyfileobj(part, out)
        return out.tell()
