"""Output shaping for registered queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import tidy


def tidied(df: DataFrame, places: int = 9) -> DataFrame:
    """Round DOUBLE columns so results do not depend on summation order."""
    return df.select(*[
        tidy(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])
