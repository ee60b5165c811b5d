"""Composed jobs: the star schema, the analyses, the report questions and KPI tables."""
