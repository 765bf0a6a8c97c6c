"""Incremental landing of feeds. The workload is batch: no watermark or state is needed."""
