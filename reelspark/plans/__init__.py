"""Job specifications, command-line grammar and the plan builder."""
