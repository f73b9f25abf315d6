"""DataFrame operators over entity-attribute-value records."""
