"""Feature operators over train and test rows."""
