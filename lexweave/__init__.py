"""lexweave: regulatory-document analytics expressed as Spark DataFrame plans."""
