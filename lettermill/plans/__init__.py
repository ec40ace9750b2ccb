"""Composed jobs: reports, mailbox ingest, task snapshot."""
