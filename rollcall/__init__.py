"""rollcall: company-record analytics as Spark DataFrame pipelines."""
