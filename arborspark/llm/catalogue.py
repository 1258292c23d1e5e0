"""What __spark_entry__.py registers from this subpackage."""

from arborspark.llm.oracles import ORACLES
from arborspark.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
