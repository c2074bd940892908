"""Reconstruction of sequence mixtures from short reads, as Spark DataFrame jobs.

Every operator takes and returns DataFrames keyed by ``sample_id``, so that many samples
run in one job.
"""
