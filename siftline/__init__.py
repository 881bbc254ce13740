"""siftline: adaptive training-data selection expressed as Spark DataFrame operators."""
