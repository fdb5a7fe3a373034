"""What a user asks for: probes, drill-downs, scoring, run comparison, message measures."""
