"""DataFrame-to-DataFrame operators shared by the loads and the reports."""
