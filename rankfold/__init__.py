"""rankfold: Spark operators for events with ranked participants."""
