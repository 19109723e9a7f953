"""Reusable segments of the reports (churn core, districts, sales, revenue)."""
