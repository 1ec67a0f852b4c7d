"""Quality of streams: windowed measures with watermarks, and profiles of micro-batches."""
