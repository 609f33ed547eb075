"""Reading and writing RDF text and table layouts."""
