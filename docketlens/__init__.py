"""docketlens: analytics over rulemaking dockets and their comments, on Spark."""
