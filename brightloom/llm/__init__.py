"""Operators of a training-data pipeline, one module per problem; nothing else imports this package."""
