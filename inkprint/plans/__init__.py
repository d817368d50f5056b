"""Registered queries: each pairs a DataFrame plan with the SQL that checks it."""
