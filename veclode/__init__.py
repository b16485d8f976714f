"""veclode: vector search, clustering and quantization as Spark DataFrame operators."""

__version__ = "0.1.0"
