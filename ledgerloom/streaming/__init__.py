"""Structured Streaming: assembly, job state, triage, retries, change feeds."""
