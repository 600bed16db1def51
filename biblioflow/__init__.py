"""Bibliographic catalogue cleaning, reconciliation and auditing on PySpark."""
