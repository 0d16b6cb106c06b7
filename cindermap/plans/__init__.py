"""End-to-end jobs: tables in, tables out. Reading and writing stays with the caller."""
