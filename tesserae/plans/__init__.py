"""Query specifications, the binding of driver tables to the model, and the registered queries."""
