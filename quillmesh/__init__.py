"""Mail, organization and event analytics declared as PySpark plans."""
