"""ledgerloom: auditable composite indices over companies and their documents, on Spark."""
