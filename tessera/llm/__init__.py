"""Operators of a training-data pipeline: exact and near deduplication,
extraction, filtering, scoring, mixing, decontamination and token output.

Every operator takes and returns DataFrames. Work that is not expressible in
Spark functions runs in Arrow batches inside Spark tasks; nothing that grows
with the corpus passes through the driver."""
