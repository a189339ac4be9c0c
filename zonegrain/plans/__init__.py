"""Views over the driver's tables, composed jobs, and the registered queries."""
