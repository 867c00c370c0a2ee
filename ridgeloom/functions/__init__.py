"""Column builders: geometry, classification and folds that Catalyst can see."""
