"""tessera: a DataFrame-first analytics engine for activity logs, text and versioned graphs."""
